"""From entries to an archive verdict: votes, proofs, endings, producers, findings and status.

Entry rows have: path, name, size (compressed bytes), label, status (attributed, unknown, insufficient, error), confidence,
setting, proof, ending, n_matches.  Everything a verdict needs of them but names is additive, so entries are first added up
into `cells` (one row for each kind of entry an archive has), which is the only shuffle of entries, with partial sums
before it; all votes work on cells and also take entries.  Ties are broken by name, ascending.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN, INSUFFICIENT, ATTRIBUTED, ERROR = "unknown", "insufficient", "attributed", "error"
# fixed values: limits of proof and verdict
PROOF_BYTES, PROOF_MATCHES, ENDING_MATCHES, STRONG = 1024, 64, 8, 0.9
ZLIB_FAMILY = ("zlib", "zlib-ng", "chromium-zlib")
MIXED_IS_INCONSISTENT = ("zip", "ooxml", "odf", "jar", "epub")
ARCHIVES = ("zip", "ooxml", "odf", "jar", "epub", "apk")

# fixed values: producers in the order they are tried (pattern, expected profiles, option bits, endings); None: not profiled
PRODUCERS = [
    ("openpyxl", "openpyxl (Python)", "openpyxl", list(ZLIB_FAMILY), [0], ["data"]),
    ("libreoffice", "LibreOffice", "LibreOffice", list(ZLIB_FAMILY), [0], ["data"]),
    ("microsoft-word", "Microsoft Word", "^Microsoft (Office )?Word$|^Microsoft Macintosh Word$", ["word", "zlib"], [3], ["flush"]),
    ("microsoft-excel", "Microsoft Excel", "^Microsoft (Office )?Excel$|^Microsoft Macintosh Excel$", None, None, None),
    ("microsoft-powerpoint", "Microsoft PowerPoint", "^Microsoft (Office )?PowerPoint$|^Microsoft Macintosh PowerPoint$", None, None, None),
    ("jdk-jar", "JDK jar tool", r"^\d+(\.\d+)*\S*\s*\([^)]*\)$", list(ZLIB_FAMILY), [0], ["data"]),
]
PRODUCER_SCHEMA = "ord int, key string, producer string, pattern string, expected array<string>, option_bits array<int>, endings array<string>"


def entry_status(error: Column, n_tokens: Column, size: Column, abstained: Column, least: int) -> Column:
    return F.when(error.isNotNull(), ERROR).when((n_tokens == 0) | (size < least), INSUFFICIENT).when(abstained, UNKNOWN).otherwise(ATTRIBUTED)


def additive(entries: DataFrame) -> DataFrame:
    """`entries` with the columns that cells add up; cells as they are."""
    if "entries" in entries.columns:
        return entries
    return entries.withColumns({"entries": F.lit(1).cast("long"), "mass": (F.col("confidence") * F.col("size")).cast("double")})


def cells(entries: DataFrame) -> DataFrame:
    """Entries of an archive that are alike in status, label, setting and ending, added up."""
    columns = entries.columns
    proof = F.col("proof").isNotNull() if "proof" in columns else F.lit(False)
    hits = F.col("zlib_hits") if "zlib_hits" in columns else F.lit(None).cast("int")
    attributed = F.col("status") == ATTRIBUTED
    keys = {"label": F.when(attributed, F.col("label")), "setting": F.when(attributed, F.col("setting")), "ending": F.when(F.col("n_matches") >= ENDING_MATCHES, F.col("ending"))}
    kinds = additive(entries).select("path", "status", *[c.alias(n) for n, c in keys.items()], "size", "confidence", "mass", proof.alias("p"), hits.alias("h"))
    return kinds.groupBy("path", "status", *keys).agg(
        F.count("*").alias("entries"), F.sum("size").alias("size"), F.sum("mass").alias("mass"), F.min("confidence").alias("confidence"), F.count_if("p").alias("proofs"),
        F.count_if(F.col("h") == 0).alias("zlib_misses"), F.count_if(F.col("h") > 0).alias("zlib_found"))


def voting(entries: DataFrame) -> DataFrame:
    """Entries that vote, by their label or as unknown."""
    some = additive(entries).where(F.col("status").isin(ATTRIBUTED, UNKNOWN))
    return some.withColumn("vote", F.when(F.col("status") == ATTRIBUTED, F.col("label")).otherwise(UNKNOWN))


def vote_shares(entries: DataFrame) -> DataFrame:
    """path, vote, n, bytes, share of bytes, share of entries."""
    each = voting(entries).groupBy("path", "vote").agg(F.sum("entries").alias("n"), F.sum("size").alias("bytes"))
    w = Window.partitionBy("path")
    return each.withColumns({"share": F.col("bytes") / F.sum("bytes").over(w), "count_share": F.col("n") / F.sum("n").over(w)})


def weighted_vote(entries: DataFrame) -> DataFrame:
    """path, profile, share: the known profile with most bytes unless unknown entries are over half by bytes or count."""
    known = F.col("vote") != UNKNOWN
    best = F.max(F.when(known, F.struct("share", F.lit(0)))).alias("best")
    per = vote_shares(entries).groupBy("path").agg(
        best, F.collect_list(F.when(known, F.struct("share", "vote"))).alias("votes"),
        F.coalesce(F.max(F.when(~known, F.col("share"))), F.lit(0.0)).alias("u_bytes"), F.coalesce(F.max(F.when(~known, F.col("count_share"))), F.lit(0.0)).alias("u_count"),
    )
    leaders = F.transform(F.filter("votes", lambda v: v["share"] == F.col("best.share")), lambda v: v["vote"])
    wins = F.col("best").isNotNull() & (F.col("u_bytes") <= 0.5) & (F.col("u_count") <= 0.5)
    return per.select("path", F.when(wins, F.array_min(leaders)).otherwise(UNKNOWN).alias("profile"), F.when(wins, F.col("best.share")).otherwise(F.col("u_bytes")).alias("share"))


def heaviest(entries: DataFrame, value: str, name: str) -> DataFrame:
    """path and the value with most bytes, the least of equal ones."""
    each = entries.where(F.col(value).isNotNull()).groupBy("path", value).agg(F.sum("size").alias("bytes"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("bytes"), value))
    return each.withColumn("rank", rank).where("rank = 1").select("path", F.col(value).alias(name))


def top_attributed(entries: DataFrame) -> DataFrame:
    return heaviest(entries.where(F.col("status") == ATTRIBUTED), "label", "closest")


def setting_vote(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Setting with most bytes among the entries that support the verdict."""
    support = entries.where(F.col("status") == ATTRIBUTED).join(verdicts.select("path", "profile"), "path").where("label = profile")
    return heaviest(support, "setting", "setting")


def archive_confidence(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Supporting confidence, weighted by bytes, over all analysable bytes."""
    rows = voting(entries).join(verdicts.select("path", "profile"), "path")
    support = (F.col("status") == ATTRIBUTED) & (F.col("label") == F.col("profile"))
    return rows.groupBy("path").agg((F.sum(F.when(support, F.col("mass")).otherwise(0.0)) / F.sum("size")).alias("confidence"))


def largest_entries(entries: DataFrame, k: int) -> DataFrame:
    """The k largest entries of every archive (top-k inside the window, before any re-encoding)."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("size"), "name"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= k)


def duplicate_names(entries: DataFrame) -> DataFrame:
    """path, name, copies of names that occur more than once."""
    return entries.groupBy("path", "name").agg(F.count("*").alias("copies")).where("copies > 1")


def odd_endings(entries: DataFrame) -> DataFrame:
    """For archives whose streams end in several ways: path, ending, n, odd (strictly fewer than the most)."""
    counted = entries if "entries" in entries.columns else additive(entries.where(F.col("n_matches") >= ENDING_MATCHES))
    each = counted.where(F.col("ending").isNotNull()).groupBy("path", "ending").agg(F.sum("entries").alias("n"))
    w = Window.partitionBy("path")
    return each.withColumns({"kinds": F.count("*").over(w), "most": F.max("n").over(w)}).where("kinds > 1").select("path", "ending", "n", (F.col("n") < F.col("most")).alias("odd"))


def family(label: Column) -> Column:
    """Libraries behind the zlib interface count as one family."""
    return F.when(label.isin(*ZLIB_FAMILY) | label.startswith("zlib"), "zlib-api").otherwise(label)


def established(entries: DataFrame, strong: float = STRONG) -> DataFrame:
    """path, label, established: any proof, or all confident, enough bytes, and zlib's exact checks not against it."""
    some = (entries if "proofs" in entries.columns else cells(entries)).where(F.col("status") == ATTRIBUTED)
    contrary = F.when(F.col("label") == "zlib", F.col("zlib_misses")).otherwise(F.col("zlib_found"))
    confident = (F.min("confidence") >= strong) & (F.sum("size") >= PROOF_BYTES) & (F.sum(contrary) == 0)
    return some.groupBy("path", "label").agg(((F.sum("proofs") > 0) | confident).alias("established"))


def producers(spark) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PRODUCERS)], PRODUCER_SCHEMA)


def match_producer(claims: DataFrame, claim: str = "claim") -> DataFrame:
    """`claims` with the first producer (six rows, broadcast) whose pattern is in the claim; nulls where none is."""
    table = F.broadcast(producers(claims.sparkSession))
    hits = claims.select(claim).distinct().join(table, F.expr(f"trim({claim}) rlike concat('(?i)', pattern)"))
    first = hits.groupBy(claim).agg(F.min(F.struct("ord", "key", "producer", "expected", "option_bits", "endings")).alias("p"))
    return claims.join(first, claim, "left").select(*claims.columns, F.col("p.key").alias("producer_key"), F.col("p.producer").alias("producer"), F.col("p.expected").alias("expected"), F.col("p.option_bits").alias("allowed_bits"), F.col("p.endings").alias("allowed_endings"))


FINDING = "struct<kind:string,check:string,text:string>"


def finding(test: Column, kind: str, check: str, *text) -> Column:
    parts = [t if isinstance(t, Column) else F.lit(t) for t in text]
    return F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(check).alias("check"), F.coalesce(F.concat(*parts), F.lit(text[0] if isinstance(text[0], str) else "")).alias("text")))


def listed(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda f: f.isNotNull()).cast(f"array<{FINDING}>")


def producer_findings(rows: DataFrame, profiles: list[str]) -> DataFrame:
    """`rows` (path, claim, profile, established, option_bits_seen, endings and the producer's columns) with findings.

    A contradiction is only reported where the verdict is established; stream endings contradict by themselves and
    replace weaker findings about the producer.
    """
    c = F.col
    known, named, profiled = c("claim").isNotNull(), c("producer").isNotNull(), c("expected").isNotNull()
    off = profiled & (c("profile") != UNKNOWN) & ~F.array_contains("expected", c("profile"))
    trained = F.size(F.array_intersect("expected", F.array(*map(F.lit, profiles)).cast("array<string>"))) > 0
    bad_end = F.coalesce(F.size(F.array_except("endings", "allowed_endings")) > 0, F.lit(False)) & named
    claim = [
        finding(~known, "info", "producer", "the container names no producer"),
        finding(known & ~named, "cannot-confirm", "producer", "'", c("claim"), "' is not in the producer table"),
        finding(named & (c("profile") == UNKNOWN) & ~bad_end, "cannot-confirm", "producer", c("producer"), " is named; the streams match no known profile"),
        finding(off & ~c("established") & ~bad_end, "cannot-confirm", "producer", c("producer"), " is named; the streams lean to '", c("profile"), "' without proof"),
        finding(off & c("established") & trained, "inconsistent", "producer", c("producer"), " is named, but the streams match '", c("profile"), "'"),
        finding(off & c("established") & ~trained & ~bad_end, "cannot-confirm", "producer", c("producer"), "'s profile is not in the model"),
        finding(named & profiled & F.array_contains("expected", c("profile")) & ~bad_end, "consistent", "producer", c("producer"), " is named, and the streams match '", c("profile"), "'"),
        finding(named & ~profiled & (c("profile") != UNKNOWN), "cannot-confirm", "producer", c("producer"), " is not profiled yet"),
        finding(bad_end, "inconsistent", "producer", c("producer"), " is named, but streams end in another way than it ends them"),
    ]
    bits = c("allowed_bits").isNotNull() & (F.size("option_bits_seen") > 0)
    fits = F.size(F.array_except("option_bits_seen", "allowed_bits")) == 0
    claim += [finding(bits & fits, "consistent", "option-bits", "option bits match ", c("producer")), finding(bits & ~fits, "inconsistent", "option-bits", "option bits differ from ", c("producer"), "'s")]
    return rows.withColumn("producer_findings", listed(*claim))


def verdict_status(findings: Column, profile: Column) -> Column:
    """inconsistent, then inconclusive (unknown, insufficient or anything that cannot be confirmed), then consistent."""
    has = lambda kind: F.exists(findings, lambda f: f["kind"] == kind)
    return F.when(has("inconsistent"), "inconsistent").when(profile.isin(UNKNOWN, INSUFFICIENT) | has("cannot-confirm"), "inconclusive").otherwise("consistent")


def mixed_finding(rows_kind: Column) -> Column:
    """The finding on entries made by different encoders: endings first, then proofs of two families, then the model's
    disagreement, which alone confirms nothing.  Columns: odd, tied, side_odd, side_tied, groups, profile."""
    severity = F.when(rows_kind.isin(*MIXED_IS_INCONSISTENT), "inconsistent").otherwise("info")
    ends, sides = (F.size("odd") > 0) | F.col("tied"), (F.size("side_odd") > 0) | F.col("side_tied")
    text = (
        F.when(F.col("tied"), "streams end in different ways, equally often").when(ends, F.concat(F.lit("odd streams end with "), F.array_join("odd", ", ")))
        .when(F.col("side_tied"), "encoders of two families are proven, equally often").otherwise(F.concat(F.lit("odd streams are proven to be made by "), F.array_join("side_odd", ", ")))
    )
    differs = F.when(ends | sides, F.struct(severity.alias("kind"), F.lit("mixed-encoders").alias("check"), text.alias("text")))
    profile = F.col("profile")
    disagree = finding(F.col("groups") > 1, "cannot-confirm", "mixed-encoders", "entries lean to different profiles, without exact evidence")
    same = finding((F.col("groups") == 1) & ~profile.isin(UNKNOWN, INSUFFICIENT), "consistent", "mixed-encoders", "all attributed entries match '", profile, "'")
    none = finding((profile == UNKNOWN) & (F.col("groups") <= 1), "cannot-confirm", "mixed-encoders", "entries match no known profile")
    return F.coalesce(differs, disagree, same, none)


NO_SIDES = "path {}, side_odd array<string>, side_tied boolean, side_named array<string>"


def verdicts(entries: DataFrame, archives: DataFrame, profiles: list[str], sides: DataFrame | None = None) -> DataFrame:
    """One row for each archive: profile, share, confidence, setting, counts by status, findings, named entries and status.

    `archives` has path, kind, claim, option_bits_seen, duplicate_names, encrypted, backslash_names; `sides` is
    `proofs.sides` of the entries.  Named entries are those that endings or proofs single out.
    """
    spark, c = entries.sparkSession, cells(entries)
    vote, odd = weighted_vote(c), odd_endings(c)
    ends = odd.groupBy("path").agg(F.sort_array(F.collect_set(F.when(F.col("odd"), F.col("ending")))).alias("odd"), (~F.bool_or("odd")).alias("tied"))
    attributed = F.when(F.col("status") == ATTRIBUTED, F.col("label"))
    by_status = [F.sum(F.when(F.col("status") == s, F.col("entries")).otherwise(0)).alias(f"n_{s}") for s in (ATTRIBUTED, UNKNOWN, INSUFFICIENT, ERROR)]
    counts = c.groupBy("path").agg(*by_status, F.count_distinct(attributed).alias("groups"), F.sum("proofs").alias("proofs"), F.sort_array(F.collect_set("ending")).alias("endings"))
    strange = entries.where(F.col("n_matches") >= ENDING_MATCHES).join(odd.where("odd").select("path", "ending"), ["path", "ending"], "left_semi")
    named = strange.groupBy("path").agg(F.sort_array(F.collect_list("name")).alias("end_named"))
    sides = sides if sides is not None else spark.createDataFrame([], NO_SIDES.format(entries.schema["path"].dataType.simpleString()))
    sure = established(c).select("path", F.col("label").alias("profile"), "established")
    parts = [vote, counts, archive_confidence(c, vote), setting_vote(c, vote), top_attributed(c), ends, named, sides]
    rows = reduce(lambda a, b: a.join(b, "path", "left"), parts, archives).join(sure, ["path", "profile"], "left")
    empty, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    defaults = dict.fromkeys(("odd", "endings", "side_odd", "side_named", "end_named"), empty) | dict.fromkeys(("tied", "side_tied", "established"), F.lit(False)) | dict.fromkeys(("groups", "proofs", *(f"n_{s}" for s in (ATTRIBUTED, UNKNOWN, INSUFFICIENT, ERROR))), zero)
    rows = rows.withColumns({n: F.coalesce(n, d) for n, d in defaults.items()} | {"profile": F.coalesce("profile", F.lit(INSUFFICIENT))})
    rows = producer_findings(match_producer(rows), profiles)
    own = listed(
        finding(F.size("duplicate_names") > 0, "inconsistent", "duplicate-names", "entry names occur more than once: ", F.array_join(F.slice("duplicate_names", 1, 20), ", ")),
        mixed_finding(F.col("kind")),
        finding(F.col("proofs") > 0, "info", "zlib-reencode", F.col("proofs").cast("string"), " entries are reproduced byte for byte"),
        finding(F.col("encrypted") > 0, "info", "encrypted", F.col("encrypted").cast("string"), " entries are encrypted and were not analysed"),
        finding(F.col("backslash_names") > 0, "info", "entry-names", F.col("backslash_names").cast("string"), " entry names use backslashes"),
    )
    claims = F.when(F.col("kind").isin(*ARCHIVES), F.col("producer_findings")).otherwise(F.array().cast(f"array<{FINDING}>"))
    by_ends = (F.size("odd") > 0) | F.col("tied")
    rows = rows.withColumns({"findings": F.concat(own, claims), "named": F.when(by_ends, F.col("end_named")).otherwise(F.col("side_named"))})
    kept = ["path", "kind", "profile", "share", "confidence", "setting", "closest", "claim", "producer", "n_attributed", "n_unknown", "n_insufficient", "n_error", "proofs", "findings", "named"]
    return rows.withColumn("status", verdict_status(F.col("findings"), F.col("profile"))).select(*kept, "status")


def weighted_explanation(items: DataFrame, n: int = 6) -> DataFrame:
    """path, feature, contribution: size-weighted means over an archive's unproven entries, the n largest by size."""
    total = items.select("path", "name", "size").distinct().groupBy("path").agg(F.sum("size").alias("total"))
    each = items.groupBy("path", "feature").agg(F.sum(F.col("size") * F.col("contribution")).alias("mass")).join(total, "path")
    each = each.select("path", "feature", (F.col("mass") / F.col("total")).alias("contribution"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.abs("contribution")), "feature"))
    return each.withColumn("rank", rank).where(F.col("rank") <= n)
