"""Extraction quality against gold records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import ratio, ratio_of
from ..functions.text import strip
from ..sources.files import any_file, numbered
from ..sources.schema import RECORD
from .authors import surname_set

FUZZY = 90.0


def norm(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text.cast("string"), F.lit(""))))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, 1.0).otherwise(both / any_)


def metadata_report(pairs: DataFrame) -> DataFrame:
    """One row of shares over (gold_X, pred_X) columns of Title, Journal, Year, Surnames."""
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    g, p = (lambda c: norm(F.col(f"gold_{c}"))), (lambda c: norm(F.col(f"pred_{c}")))
    return pairs.agg(
        F.count("*").alias("n"),
        share(g("Title") == p("Title")).alias("title_exact"),
        share(ratio_of(g("Title"), p("Title")) >= FUZZY).alias("title_fuzzy"),
        share(F.coalesce(F.col("gold_Year") == F.col("pred_Year"), F.lit(False))).alias("year_exact"),
        share(ratio_of(g("Journal"), p("Journal")) >= FUZZY).alias("journal_fuzzy"),
        F.coalesce(F.avg(jaccard(F.col("gold_Surnames"), F.col("pred_Surnames"))), F.lit(0.0)).alias("author_jaccard"),
    )


def reference_matches(titles: DataFrame) -> DataFrame:
    """(paper_id, n_gold, n_pred, tp, fp, fn) of rows (paper_id, side, ord, Title); side is gold or pred. Gold titles in order
    each take the best title left, if it is near enough."""

    def letters(titles: list[str]) -> np.ndarray:
        """How often each of 64 kinds of letter is in each title."""
        out = np.zeros((len(titles), 64), np.int32)
        for k, t in enumerate(titles):
            np.add.at(out[k], np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, 1)
        return out

    def couples(titles: list[str]) -> np.ndarray:
        """How often each of 128 kinds of neighbouring letters is in each title."""
        out = np.zeros((len(titles), 128), np.int16)
        for k, t in enumerate(titles):
            c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
            out[k] = np.minimum(np.bincount((c[:-1] * 31 + c[1:]) % 128, minlength=128), 16000)
        return out

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        gold, found = ([str(t or "").strip().lower() for t in pdf.Title[pdf.side == s]] for s in ("gold", "pred"))
        n, hits, left = len(found), 0, np.ones(len(found), bool)
        have, two, size, exact = letters(found), couples(found), np.array([len(t) for t in found], float), {}
        ranked = np.argsort(size, kind="stable")
        sizes = size[ranked]
        for k in reversed(range(n)):
            exact.setdefault(found[k], []).append(k)  # the first is the last of its list
        for title, own in zip(gold, letters(gold), strict=True):
            same = exact.get(title)
            if same:  # nothing is nearer than an equal title
                best = same.pop()
            else:
                # Lengths must be near; a subsequence has no more of a letter than either side; and each letter put in or
                # left out changes three couples of letters at most. What can't reach the threshold by these is out.
                n_own, slack = len(title), 2 - FUZZY / 100
                lo, hi = np.searchsorted(sizes, n_own * (FUZZY / 100) / slack - 1e-6), np.searchsorted(sizes, n_own * slack / (FUZZY / 100) + 1e-6, "right")
                near = np.sort(ranked[lo:hi])
                near = near[left[near]]
                total = size[near] + n_own
                near = near[np.where(total > 0, 200 * np.minimum(have[near], own).sum(1) / np.maximum(total, 1), 100) >= FUZZY - 1e-9]
                apart = np.abs(two[near] - couples([title])).sum(1)
                near = near[apart <= 3 * (1 - FUZZY / 100) * (size[near] + n_own) + 1e-6]
                scores = {int(k): ratio(title, found[k]) for k in near}
                best = max(scores, key=scores.__getitem__, default=None)
                if best is None or scores[best] < FUZZY:
                    continue
                exact[found[best]].remove(best)
            left[best] = False
            hits += 1
        return pd.DataFrame([(pdf.paper_id.iloc[0], len(gold), n, hits, n - hits, len(gold) - hits)], columns=["paper_id", "n_gold", "n_pred", "tp", "fp", "fn"])

    return titles.groupBy("paper_id").applyInPandas(match, "paper_id string, n_gold int, n_pred int, tp int, fp int, fn int")


def precision_recall(matches: DataFrame) -> DataFrame:
    total = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    part = lambda a, b: F.when(a + b > 0, F.col("tp") / (a + b)).otherwise(0.0)
    out = total.withColumns({"precision": part(F.col("tp"), F.col("fp")), "recall": part(F.col("tp"), F.col("fn"))})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


GOLD = f"source_file string, metadata struct<{RECORD}>, references array<struct<{RECORD}>>"


def evaluate(spark: SparkSession, gold: str, papers: DataFrame, references: DataFrame, raw: DataFrame | None = None) -> dict:
    """Reports on metadata, references and clusters, from a folder of gold files (a JSON each, and dedup_pairs.json).

    papers has source_file and a record's fields; references source_file, position and Title of what was extracted. A gold
    paper that is not among papers is skipped, and in the reference report one without extracted references. Pairs of
    ordinals in dedup_pairs.json are compared by cited_id, where raw has it."""
    files = spark.read.schema(GOLD).option("multiLine", True).option("pathGlobFilter", "*.json").json(gold).where("source_file IS NOT NULL")
    both = files.join(papers.select("source_file", F.struct("Title", "Authors_List", "Journal", "Year").alias("found")), "source_file")
    surnames = lambda c: surname_set(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lit(""))
    sides = {f"{side}_{f}": F.col(f"{c}.{f}") for side, c in (("gold", "metadata"), ("pred", "found")) for f in ("Title", "Journal", "Year")}
    pairs = both.withColumns({**sides, "gold_Surnames": surnames("metadata.Authors_List"), "pred_Surnames": surnames("found.Authors_List")})
    had = both.join(references.select("source_file").distinct(), "source_file", "left_semi").select("source_file", "references")
    wanted = had.select(F.col("source_file").alias("paper_id"), F.lit("gold").alias("side"), F.posexplode("references").alias("ord", "r")).select("paper_id", "side", F.col("ord").cast("long").alias("ord"), "r.Title")
    got = references.join(had.select("source_file"), "source_file", "left_semi").select(F.col("source_file").alias("paper_id"), F.lit("pred").alias("side"), F.col("position").cast("long").alias("ord"), "Title")
    report = {"metadata": metadata_report(pairs).first().asDict(), "references": precision_recall(reference_matches(wanted.unionByName(got))).first().asDict(), "dedup": None}
    if any_file(spark, gold, "dedup_pairs.json") and raw is not None:
        if "cited_id" not in raw.columns:
            report["dedup"] = {"note": "pairs are not compared: raw references have no cited_id"}
        else:
            ij = spark.read.schema("value string").text(f"{gold.rstrip('/')}/dedup_pairs.json", wholetext=True).select(F.explode(F.from_json("value", "array<array<long>>")).alias("p")).select(F.col("p")[0].alias("i"), F.col("p")[1].alias("j"))
            total = ij.count()
            share = dedup_share(ij, numbered(raw, "source_file", "position").select("ord", F.col("cited_id").alias("leader"))).first()
            report["dedup"] = {"n_pairs": total, "n_correct": round(share["share"] * total), "accuracy": share["share"]}
    return report


def report_text(report: dict) -> str:
    """The report as markdown."""
    m, r, d = report["metadata"], report["references"], report.get("dedup")
    shares = [("Title, exact", "title_exact"), (f"Title, at least {FUZZY:.0f} alike", "title_fuzzy"), ("Year", "year_exact"), (f"Journal, at least {FUZZY:.0f} alike", "journal_fuzzy")]
    lines = ["# Evaluation", "", f"## Metadata of {m['n']} papers", "", *(f"- {name}: {m[key]:.1%}" for name, key in shares), f"- Authors, mean Jaccard of surnames: {m['author_jaccard']:.2f}"]
    lines += ["", "## References", "", f"- Right {r['tp']}, wrong {r['fp']}, missed {r['fn']}", *(f"- {k.capitalize()}: {r[k]:.1%}" for k in ("precision", "recall", "f1"))]
    if d:
        lines += ["", "## Clusters", "", f"- {d['note']}" if "note" in d else f"- {d['n_correct']} of {d['n_pairs']} pairs together ({d['accuracy']:.1%})"]
    return "\n".join(lines) + "\n"


def dedup_share(gold_pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Share of gold pairs (i, j) of ordinals that are in one cluster of mapping (ord, leader)."""
    a, b = (mapping.select(F.col("ord").alias(k), F.col("leader").alias(f"{k}_leader")) for k in ("i", "j"))
    return gold_pairs.join(a, "i", "left").join(b, "j", "left").agg(F.count("*").alias("n_pairs"), F.coalesce(F.avg(F.coalesce(F.col("i_leader") == F.col("j_leader"), F.lit(False)).cast("int")), F.lit(0.0)).alias("share"))
