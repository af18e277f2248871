"""Reports from aggregates: a JSON document, Markdown, and lines for the console. Only small frames are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scalars as S
from holdfast.operators import inventory as I


def summary(objects: DataFrame, checkpoints: DataFrame | None = None, top_ext: int = 25, top_prefixes: int = 25) -> dict:
    """Corpus totals, buckets, their leading extensions and prefixes, and duplicates, as one document."""
    buckets: dict[str, dict] = {r["bucket"]: {k: v for k, v in r.asDict().items() if k != "bucket"} | {"by_extension": {}, "prefixes": {}, "complete": False} for r in I.bucket_matrix(objects).collect()}
    for dim, name, k in (("ext", "by_extension", top_ext), ("prefix", "prefixes", top_prefixes)):
        for r in I.top_k(I.dimension_counts(objects, (dim,)), k, [F.desc("objects"), F.col("value")], ["bucket"]).orderBy("bucket", F.desc("objects"), "value").collect():
            buckets[r["bucket"]][name][r["value"]] = {"objects": r["objects"], "bytes": r["bytes"]}
    if checkpoints is not None:
        for r in checkpoints.select("bucket", "complete").collect():
            if r["bucket"] in buckets:
                buckets[r["bucket"]]["complete"] = r["complete"]
    dup = I.duplicate_totals(objects).first().asDict()
    dup["largest_groups"] = [{"etag": r["etag"], "copies": r["copies"], "keys": r["keys"].split("\n")} for r in I.largest_groups(objects).orderBy(F.desc("copies"), "etag").collect()]
    return {"corpus": I.corpus_totals(objects).first().asDict(), "buckets": buckets, "duplicates": dup}


def human(n: int) -> str:
    """As :func:`holdfast.functions.scalars.human_bytes`, for one number."""
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        if abs(n) < 1024:
            return f"{n:,} B"
        if abs(n) < 1024 ** (power + 1):
            return f"{n / 1024**power:,.1f} {unit}"
    return f"{n / 1024**4:,.1f} TB"


def markdown(doc: dict, ext: int = 10, prefixes: int = 12) -> str:
    """The summary as Markdown: totals, a row for each bucket by size, and each bucket's leading extensions and prefixes."""
    c = doc["corpus"]
    out = ["# Corpus inventory", "", f"- objects: {c['objects']:,} ({human(c['bytes'])})", f"- documents: {c['documents']:,} ({human(c['document_bytes'])})", f"- PDFs: {c['pdfs']:,} ({human(c['pdf_bytes'])})", f"- noise: {c['noise_objects']:,} ({human(c['noise_bytes'])})", ""]
    out += ["| bucket | objects | size | documents | PDFs | web | media | other | noise |", "|---|---|---|---|---|---|---|---|---|"]
    ordered = sorted(doc["buckets"].items(), key=lambda b: (-b[1]["bytes"], b[0]))
    for name, b in ordered:
        out.append(f"| {name} | {b['objects']:,} | {human(b['bytes'])} | {b['document_objects']:,} | {b['pdfs']:,} | {b['web_objects']:,} | {b['media_objects']:,} | {b['other_objects']:,} | {b['noise_objects']:,} |")
    for name, b in ordered:
        out += ["", f"## {name}" + ("" if b["complete"] else " (partial)"), ""]
        out += [f"- `{k}`: {v['objects']:,} ({human(v['bytes'])})" for k, v in list(b["by_extension"].items())[:ext]]
        out += [""] + [f"- `{k}/`: {v['objects']:,} ({human(v['bytes'])})" for k, v in list(b["prefixes"].items())[:prefixes]]
    d = doc["duplicates"]
    out += ["", "## Duplicates", "", f"{d['identical_groups']:,} groups, {d['cross_bucket_groups']:,} of them over several buckets, {d['redundant_objects']:,} redundant objects.", ""]
    out += [f"- {g['copies']} x `{g['etag']}`: {g['keys'][0]}" for g in d["largest_groups"]]
    return "\n".join(out) + "\n"


def digest(doc: dict) -> list[str]:
    """One line for each bucket, largest first, with a mark on partial ones."""
    return [f"{n}: {b['objects']:,} objects, {human(b['bytes'])}" + ("" if b["complete"] else " PARTIAL") for n, b in sorted(doc["buckets"].items(), key=lambda b: (-b[1]["bytes"], b[0]))]


def year_chart(objects: DataFrame, width: int = 60) -> DataFrame:
    """``(year, objects, bar)``: bars in proportion to the largest year, at most ``width`` long."""
    y = I.value_counts(objects, "year").select("year", "objects")
    top = y.agg(F.max("objects").alias("top"))  # one row
    n = F.greatest(F.lit(1), F.expr(f"objects * {width} div top")).cast("int")
    return y.join(F.broadcast(top)).select("year", "objects", F.repeat(F.lit("#"), n).alias("bar"))


def type_shares(objects: DataFrame) -> DataFrame:
    """``(ctype, objects, share)`` of all objects."""
    t = I.value_counts(objects, "ctype")
    whole = t.agg(F.sum("objects").alias("whole"))  # one row
    return t.join(F.broadcast(whole)).select("ctype", "objects", F.round(S.share(F.col("objects"), F.col("whole")), 6).alias("share"))


def console(objects: DataFrame, sample: int = 20) -> list[str]:
    """The lines of a report on one listing: sizes, types with their shares, extensions, prefixes, years, duplicates, classes with a
    warning of archive tiers, empty objects, and a sample of keys. Only leading rows are collected."""

    def section(title: str) -> None:
        out.extend(["", title, "-" * len(title)])

    out: list[str] = ["Inventory report", "================"]
    total = objects.agg(F.count("*").alias("n"), F.coalesce(F.sum(S.size_of(F.col("size"))), F.lit(0)).alias("b")).first()
    out.append(f"Objects: {total['n']:,}   Total: {human(total['b'])}")
    section("Size distribution")
    for r in I.size_summary(objects.withColumn("bucket", F.lit("all"))).collect():
        out += [f"  {c:>5}: {human(r[c])}" for c in ("min", "p50", "p90", "p99", "max", "mean")]
    section("By content type")
    for r in type_shares(objects).orderBy(F.desc("objects"), "ctype").collect():
        out.append(f"  {r['ctype']:<8} {r['objects']:>7,}  ({r['share']:>5.1%})")
    for title, dim, k in (("By extension", "ext", 25), ("Top-level prefixes", "top", 40)):
        section(title)
        out += [f"  {r[dim]:<44} {r['objects']:>7,}" for r in I.top_k(I.value_counts(objects, dim), k, [F.desc("objects"), F.col(dim)]).collect()]
    section("By year of modification")
    out += [f"  {r['year']}  {r['objects']:>7,}  {r['bar']}" for r in year_chart(objects).orderBy("year").collect()]
    section("Duplication")
    d, names = I.duplicate_totals(objects).first(), I.name_size_collisions(objects).agg(F.coalesce(F.sum("collision_groups"), F.lit(0)).alias("n")).first()["n"]
    out += [f"  same name and size: {names:,} groups", f"  identical ETag: {d['identical_groups']:,} groups, {d['redundant_objects']:,} redundant objects"]
    out += [f"    x{r['copies']}  {k}" if not n else f"          {k}" for r in I.largest_groups(objects, 10, 5).orderBy(F.desc("copies"), "etag").collect() for n, k in enumerate(r["keys"].split("\n"))]
    section("Storage classes")
    classes = I.value_counts(objects, "class").orderBy("class").collect()
    out += [f"  {r['class']:<24} {r['objects']:>7,}" for r in classes]
    if any("GLACIER" in r["class"] or "DEEP" in r["class"] for r in classes):
        out.append("  WARNING: objects of archive tiers must be restored, at a price, before they can be read.")
    empty = I.zero_byte(objects.withColumn("bucket", F.lit("all"))).orderBy("key").collect()
    if empty:
        section("Empty objects")
        out += [f"  {empty[0]['zero_byte_objects']:,} found, among them:"] + [f"    {r['key']}" for r in empty]
    section(f"Sample of {sample} keys")
    return out + [f"  {r['bucket']}::{r['key']}" for r in I.stride_sample(objects, sample).orderBy("pos").collect()]
