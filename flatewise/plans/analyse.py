"""Analysis of files: scan, decode, describe, attribute, prove, and one verdict a file.

Control crosses into Python in three kernels (containers, decoding, exact re-encoding).  Exact re-encoding runs on the
largest entries of each archive only, chosen before the kernel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flatewise.functions import features, rules
from flatewise.operators import streams
from flatewise.plans import proofs
from flatewise.plans import verdict as V
from flatewise.plans.model import Model
from flatewise.sources import containers

# fixed value: entries of a file that are re-encoded
REENCODE_LIMIT = 400


def described(found: DataFrame) -> DataFrame:
    """Stream rows with features, rule hits, ending and totals; payload and output stay for the proof kernel."""
    keep = ["path", "kind", "name", "index", "payload"]
    rows = found.select(*keep, F.col("payload").alias("_p"))
    records = streams.decode(rows, "_p", keep=keep, output=True, decide=True, max_bytes=streams.CAP_BYTES)
    total = lambda n: F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b[n])
    return features.add_features(records, [*keep, "output", "compressed_bytes", "out_size", "capped", "error", "ending", rules.signatures().alias("signatures"), total("matches").alias("n_matches"), total("n_tokens").alias("n_tokens"), F.size("blocks").alias("n_blocks")])


def with_proofs(rows: DataFrame, profiles: list[str], limit: int = REENCODE_LIMIT) -> DataFrame:
    """zlib_proof, zlib_hits and reproduced of the largest complete streams of each file; null where a stream was not tried."""
    order = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("size"), "name", "index"))
    ranked = rows.withColumn("tried", (order <= limit) & F.col("error").isNull() & ~F.col("capped"))
    tried = streams.references(streams.proofs(ranked.where("tried")), profiles).drop("payload", "output", "tried")
    nothing = {"zlib_proof": F.lit(None).cast("string"), "zlib_hits": F.lit(None).cast("int"), "reproduced": F.lit(None).cast("map<string,string>")}
    rest = ranked.where("not tried").drop("payload", "output", "tried").withColumns(nothing)
    return tried.withColumn("zlib_hits", F.col("zlib_proof").isNotNull().cast("int")).unionByName(rest)


def entries(files: DataFrame, model: Model | None = None, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entry rows, reports) of (path, content) files.

    A proof needs enough bytes and matches; it overrides the prediction: label zlib, confidence 1, the proven setting.
    """
    reports = containers.scan_table(files)
    reports = reports.checkpoint() if files.sparkSession.sparkContext.getCheckpointDir() else reports
    rows = described(containers.stream_rows(reports)).withColumn("size", F.when(F.col("capped"), F.octet_length("payload")).otherwise(F.col("compressed_bytes")))
    rows = with_proofs(rows, model.classes if model else [])
    least = least if least is not None else (model.min_bytes if model else V.PROOF_BYTES)
    if model:
        rows = model.predict(rows).withColumnRenamed("reason", "status_reason")
    else:
        rows = rows.withColumns({"label": F.lit("unknown"), "confidence": F.lit(0.0), "abstained": F.lit(True), "novelty": F.lit(None).cast("double"), "status_reason": F.lit("no model"), "proba": F.lit(None).cast("map<string,double>")})
    provable = (F.col("size") >= F.greatest(F.lit(V.PROOF_BYTES), F.lit(least))) & (F.col("n_matches") >= V.PROOF_MATCHES)
    proven = F.col("zlib_proof").isNotNull() & provable
    rows = rows.withColumns({"provable": provable, "proof": F.when(proven, F.lit("zlib")), "setting": F.when(F.col("zlib_proof").isNotNull(), F.col("zlib_proof"))})
    status = F.when(proven, V.ATTRIBUTED).otherwise(V.entry_status(F.col("error"), F.col("n_tokens"), F.col("size"), F.col("abstained"), least))
    rows = rows.withColumns({"status": status, "label": F.when(proven, "zlib").otherwise(F.col("label")), "confidence": F.when(proven, 1.0).otherwise(F.col("confidence")), "method": F.lit("deflate")})
    kept = ["path", "name", "index", "method", "size", "out_size", "n_blocks", "n_matches", "ending", "status", "status_reason", "error", "label", "confidence", "novelty", "setting", "proof", "zlib_hits", "signatures", "provable", "proba", "reproduced"]
    other = containers.entry_rows(reports).where("stream_index is null").select(
        "path", "name", F.lit(None).cast("int").alias("index"), F.when(F.col("encrypted"), "encrypted").when(F.col("method") == 0, "stored").when(F.col("status") == "error", "damaged").otherwise("other").alias("method"),
        F.col("csize").alias("size"), F.when(F.col("status") == "error", V.ERROR).otherwise(V.INSUFFICIENT).alias("status"))
    return rows.select(*kept).unionByName(other, allowMissingColumns=True), reports


def archives_of(reports: DataFrame) -> DataFrame:
    return reports.where("error is null").select("path", "kind", F.try_element_at("claims", F.lit("producer")).alias("claim"), "option_bits_seen", "duplicate_names", "encrypted", "backslash_names")


def analyse(files: DataFrame, model: Model | None = None) -> DataFrame:
    """One verdict row a readable file, and an error row for each other file."""
    rows, reports = entries(files, model)
    if files.sparkSession.sparkContext.getCheckpointDir():
        rows = rows.checkpoint()  # the verdict reads entries several times; the kernels run once
    if model:
        rows = proofs.proven(rows)
        rows = rows.checkpoint() if files.sparkSession.sparkContext.getCheckpointDir() else rows
    profiles = model.classes if model else ["zlib"]
    found = V.verdicts(rows, archives_of(reports), profiles, proofs.sides(rows))
    failed = reports.where("error is not null").select("path", F.lit("error").alias("status"), F.array(F.struct(F.lit("info").alias("kind"), F.lit("container").alias("check"), F.col("error").alias("text"))).cast(f"array<{V.FINDING}>").alias("findings"))
    return found.unionByName(failed, allowMissingColumns=True)


def analyse_path(spark: SparkSession, path: str, model: Model | None = None) -> DataFrame:
    return analyse(containers.read_files(spark, path), model)


# fixed values: extra fields that have a feature of their own
EXTRA_IDS = ("0x0001", "0x000A", "0x5455", "0x7875", "0xCAFE", "0x7075", "0x6375", "0x5855")


def metadata_features(reports: DataFrame) -> DataFrame:
    """What headers alone tell of an archive, as numbers by path: the input of the metadata baseline."""
    e = F.filter("entries", lambda x: x["method"] == 8)
    first = F.coalesce(F.try_element_at(e, F.lit(1)), F.try_element_at("entries", F.lit(1)))
    of = lambda s, name: F.coalesce(F.try_element_at(s["metadata"], F.lit(name)), F.lit(""))
    head = F.try_element_at("streams", F.lit(1))["metadata"]
    number = lambda name: F.coalesce(F.try_element_at(head, F.lit(name)).try_cast("long"), F.lit(0).cast("long"))
    overall = lambda name: F.coalesce(F.try_element_at("metadata", F.lit(name)).try_cast("double"), F.lit(0.0))
    extras = F.array_distinct(F.filter(F.transform(F.flatten(F.transform("streams", lambda s: F.split(F.regexp_replace(of(s, "extra"), r"[\[\]' ]", ""), ","))), lambda x: F.substring_index(x, ":", 1)), lambda x: x != ""))
    times = F.transform("streams", lambda s: of(s, "time"))
    n = F.greatest(F.size("entries"), F.lit(1))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    values = {
        "host": F.shiftright(first["version_made_by"], 8), "version": first["version_made_by"].bitwiseAND(255), "descriptor": first["flags"].bitwiseAND(8) != 0, "utf8": first["flags"].bitwiseAND(0x800) != 0, "option_bits": first["option_bits"],
        "n_extra": F.size(extras), "extra_unknown": F.exists(extras, lambda x: ~x.isin(*EXTRA_IDS)), "date_1980": F.exists(times, lambda t: t.startswith("1980")), "odd_seconds": F.lit(0.0), "timestamps_share": F.size(F.array_distinct(times)) / F.greatest(F.size(times), F.lit(1)),
        "unix_attributes": F.shiftright(number("external_attr"), 16) != 0, "no_attributes": number("external_attr") == 0, "text_attribute": number("internal_attr").bitwiseAND(1), "stored_share": F.size(F.filter("entries", lambda x: x["method"] == 0)) / n,
        "comment_length": overall("comment_length"), "prepended": overall("prepended_bytes") > 0, "has_entries": F.size("entries") > 0, **{f"extra_{x}": F.array_contains(extras, x) for x in EXTRA_IDS},
    }
    return reports.where(F.size("entries") > 0).select("path", *[flag(c).alias(k) for k, c in values.items()])


def metadata_robustness(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, index, change: greatest difference of a stream's features before and after headers were rewritten (0)."""
    a = features.stream_features(containers.stream_rows(before).select("path", "index", "payload")).select("path", "index", F.col("f").alias("a"))
    b = features.stream_features(containers.stream_rows(after).select("path", "index", "payload")).select("path", "index", F.col("f").alias("b"))
    return a.join(b, ["path", "index"]).select("path", "index", F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("change"))


def padding_score(records: DataFrame) -> DataFrame:
    """Corpus score of the padding channel over decoded records."""
    padded, odd = F.count_if(F.col("pad_bits") > 0), F.count_if((F.col("pad_bits") > 0) & (F.col("pad_value") != 0))
    share = F.coalesce(odd / F.nullif(padded, F.lit(0)), F.lit(0.0))
    return records.agg(F.count("*").alias("streams"), padded.alias("with_padding"), odd.alias("nonzero_padding"), share.alias("share_of_padded"), ((share > 0.30) & (padded >= 8)).alias("suspicious"))


def edit_outcome(findings: DataFrame) -> DataFrame:
    """path, flagged, localised: an edited entry was reported, and it alone was named (named and edited are columns)."""
    return findings.select("path", (F.size("named") > 0).alias("flagged"), (F.sort_array("named") == F.array("edited")).alias("localised"))
