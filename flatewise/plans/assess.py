"""Assessment of models: settings, masks, baselines, experiments on archives, and the run that puts them together.

Row-wise judgements are set-aware: several programs can make the same stream, so a row has `profiles` (all that make
it), `settings` (profile to the settings that do) and is right if its label is one of them.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flatewise.operators import encoders, rewrite, streams
from flatewise.plans import analyse
from flatewise.plans import evaluation as E
from flatewise.plans import model as M
from flatewise.plans import verdict as V
from flatewise.sources import containers, corpus

# fixed values: sample sizes and limits of the assessments
PER_PROFILE, LEAST_ROWS, SETTING_TREES, METADATA_TREES, APP_STREAMS, APP_SHARE, PARTS = 40, 5, 40, 60, 200, 0.95, 5


# ---- settings ------------------------------------------------------------------------------------------------------


def canonical_setting(settings: Column) -> Column:
    """One name for a set of equivalent settings: a plain one before those of other programs (`program:setting`), then
    by the number in it, then by name."""
    plain = F.filter(settings, lambda s: ~s.contains(":"))

    def order(s):
        digits = F.regexp_replace(F.element_at(F.split(s, ":"), -1), "[^0-9]", "")
        return F.struct((digits == "").alias("bare"), F.coalesce(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(0).cast("long")).alias("n"), s.alias("s"))

    return F.array_min(F.transform(F.when(F.size(plain) > 0, plain).otherwise(settings), order))["s"]


def setting_models(model: M.Model, rows: DataFrame, trees: int = SETTING_TREES) -> dict[str, tuple[list[str], object]]:
    """For each profile the names of its settings and a forest that tells them apart (none for a single one), from rows
    (profile, settings, f).  Profiles are few; each is one distributed fit."""
    labelled = E.cut(model.scaled(rows.withColumn("setting", canonical_setting(F.col("settings")))).select("profile", "setting", "x"))
    names = {r[0]: sorted(r[1]) for r in labelled.groupBy("profile").agg(F.collect_set("setting")).collect()}
    out = {}
    for k, profile in enumerate(sorted(names)):
        forest = None
        if len(names[profile]) > 1:
            index = F.array_position(F.array(*map(F.lit, names[profile])), F.col("setting"))
            train = labelled.where(F.col("profile") == profile).select("x", (index - 1).cast("double").alias("label"))
            forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=M.DEPTH, featureSubsetStrategy="sqrt", seed=k + 1).fit(train)
        out[profile] = names[profile], forest
    return out


def with_settings(model: M.Model, found: dict, rows: DataFrame) -> DataFrame:
    """Predicted rows (label, f) with setting and setting_share, by the model of their label; null for other labels."""
    parts = [rows.where(~F.col("label").isin(*found)).withColumns({"setting": F.lit(None).cast("string"), "setting_share": F.lit(None).cast("double")})]
    for profile, (names, forest) in found.items():
        mine = rows.where(F.col("label") == profile)
        if forest is None:
            parts.append(mine.withColumns({"setting": F.lit(names[0]), "setting_share": F.lit(1.0)}))
            continue
        scored = forest.transform(model.scaled(mine)).withColumn("p", vector_to_array("probability"))
        at = F.array_position("p", F.array_max("p")).cast("int")
        parts.append(scored.withColumns({"setting": F.element_at(F.array(*map(F.lit, names)), at), "setting_share": F.array_max("p")}).select(*rows.columns, "setting", "setting_share"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def setting_metrics(rows: DataFrame) -> DataFrame:
    """label, n, accuracy of the settings of answered rows whose label is right."""
    judged = rows.where(~F.col("abstained") & F.array_contains("profiles", F.col("label")) & F.col("setting").isNotNull())
    right = F.coalesce(F.array_contains(F.try_element_at("settings", F.col("label")), F.col("setting")), F.lit(False))
    return judged.groupBy("label").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


# ---- what takes part ------------------------------------------------------------------------------------------------


def selection(rows: DataFrame, split: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """`rows` with in_train and in_test, from split (source_id, split).

    Generated and file sources follow their source's split, rows of applications their own.  Training takes rows of
    one profile that is neither synthetic nor excluded; the test takes all rows of test sources that are not synthetic.
    """
    own = rows.columns
    split_of = split.select("source_id", F.col("split").alias("_source_split"))
    joined = rows.join(split_of, "source_id", "left")
    app = F.col("origin") == "app" if "origin" in own else F.lit(False)
    given = F.col("split") if "split" in own else F.lit(None).cast("string")
    part = F.when(app, F.when(given == "holdout", "test").otherwise(given)).otherwise(F.col("_source_split"))
    excluded = F.col("profile").isin(*exclude) if exclude else F.lit(False)
    usable = F.col("profile").isNotNull() & ~F.col("synthetic") & ~F.coalesce(excluded, F.lit(False))
    flags = {"in_train": F.coalesce((part == "train") & usable, F.lit(False)), "in_test": F.coalesce((part == "test") & ~F.col("synthetic"), F.lit(False))}
    return joined.withColumns(flags).select(*own, *flags)


def add_application(rows: DataFrame, library: str) -> DataFrame:
    """Rows (hash, size, reproduced) of an application's files with profile and split.

    If its library makes nearly all of its largest streams, the application takes the library's profile, else its own
    (`app`).  Rows are split by content; a held-out row that equals a training row is one too.
    """
    large = Window.partitionBy("app").orderBy(F.desc("size"), "hash")
    share = rows.withColumn("rank", F.row_number().over(large)).where(F.col("rank") <= APP_STREAMS).groupBy("app").agg(F.avg(F.col("reproduced").cast("double")).alias("share"))
    split = rows.select("*", E.hash_parity(F.col("file_hash")).alias("_own"))
    seen = split.groupBy("hash").agg(F.max((F.col("_own") == "train").cast("int")).alias("_seen"))
    joined = split.join(seen, "hash").join(F.broadcast(share), "app")
    return joined.select(*rows.columns, F.when(F.col("share") >= APP_SHARE, F.lit(library)).otherwise(F.col("app")).alias("profile"), F.when(F.col("_seen") == 1, "train").otherwise("holdout").alias("split"))


def regenerate(rows: DataFrame, sources: DataFrame, pairs: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(streams, missing): the corpus rows (source_id, hash) with their payload made anew from the sources, and those that
    no setting at hand makes."""
    made = streams.compress(sources.select("source_id", "content"), pairs or corpus.settings()).withColumn("hash", F.sha2("payload", 256))
    made = made.groupBy("source_id", "hash").agg(F.first("payload").alias("payload"))
    keys = rows.select("source_id", "hash").distinct()
    return keys.join(made, ["source_id", "hash"]), keys.join(made, ["source_id", "hash"], "left_anti")


def profile_info(rows: DataFrame) -> DataFrame:
    """profile, program, settings, streams: what makes up each profile, from corpus rows with labels `program:setting`."""
    each = rows.where("profile is not null").select("profile", F.explode("labels").alias("l"))
    parts = F.split("l", ":", 2)
    return each.groupBy("profile", parts[0].alias("program")).agg(F.sort_array(F.collect_set(parts[1])).alias("settings"), F.count("*").alias("streams"))


def training_info(rows: DataFrame) -> DataFrame:
    """streams, sources, profiles and bytes of the rows a model was fitted on."""
    return rows.agg(F.count("*").alias("streams"), F.count_distinct("source_id").alias("sources"), F.sort_array(F.collect_set("profile")).alias("profiles"), F.sum("compressed_bytes").alias("compressed_bytes"))


# ---- metrics and baselines -------------------------------------------------------------------------------------------


def novelty_report(model: M.Model, rows: DataFrame) -> dict[str, DataFrame]:
    """known: shares of held-out rows (profile, f) that confidence, novelty or either reject.  unseen: for each profile the
    share that novelty alone would reject had the model no references of it."""
    scored = E.cut(model.score(rows.where(F.col("profile").isin(*model.classes))).select("profile", "z", "confidence", "novelty"))
    weak, strange = F.col("confidence") < model.min_confidence, F.col("novelty") > model.max_novelty
    share = lambda c: F.avg(c.cast("double"))
    known = scored.agg(share(weak).alias("rejected_by_confidence"), share(strange).alias("rejected_by_novelty"), share(weak | strange).alias("rejected_by_either"))
    without = F.lit(float("inf"))
    for name in model.classes:
        others = [(s, v) for label, s, v in model.references if label != name]
        without = F.when(F.col("profile") == name, E.nearest_reference(F.col("z"), others, M.novelty_columns())).otherwise(without)
    unseen = scored.withColumn("d", without).groupBy("profile").agg(F.count("*").alias("n"), share(F.col("d") > model.max_novelty).alias("rejected_by_novelty")).where(F.col("n") >= LEAST_ROWS)
    return {"known": known, "unseen": unseen}


def comparison(rows: DataFrame, methods: list[str], per_profile: int = PER_PROFILE) -> DataFrame:
    """method, n, correct, wrong, none and the counts of a zlib detector, on at most `per_profile` rows a profile in the
    order of their hash.  Each method is a column of labels; null and unknown are no answer."""
    sample = E.stratified(rows, "profile", "hash", per_profile)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("said")) for m in methods]))
    each = sample.select("profiles", pairs.alias("m")).select("profiles", "m.*")
    silent = F.col("said").isNull() | (F.col("said") == V.UNKNOWN)
    right, is_zlib, says_zlib = F.array_contains("profiles", F.col("said")), F.array_contains("profiles", F.lit("zlib")), F.coalesce(F.col("said") == "zlib", F.lit(False))
    return each.groupBy("method").agg(
        F.count("*").alias("n"), F.count_if(~silent & right).alias("correct"), F.count_if(~silent & ~right).alias("wrong"), F.count_if(silent).alias("none"),
        F.count_if(is_zlib & says_zlib).alias("zlib_hits"), F.count_if(~is_zlib & says_zlib).alias("zlib_false"), F.count_if(is_zlib & ~says_zlib).alias("zlib_missed"))


def metadata_model(reports: DataFrame, label: str, trees: int = METADATA_TREES):
    """(classes, forest) that tells writers apart by what headers say, from reports with a label column."""
    x = metadata_vectors(reports, label)
    classes = [r[0] for r in x.select(label).distinct().orderBy(label).collect()]
    index = F.array_position(F.array(*map(F.lit, classes)), F.col(label))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=10, featureSubsetStrategy="all", seed=1)
    return classes, forest.fit(x.withColumn("y", (index - 1).cast("double")))


def metadata_vectors(reports: DataFrame, *keep: str) -> DataFrame:
    features = analyse.metadata_features(reports)
    numbers = [c for c in features.columns if c != "path"]
    return features.join(reports.select("path", *keep), "path").select("path", *keep, array_to_vector(F.array(*numbers)).alias("x"))


def metadata_predictions(found, reports: DataFrame) -> DataFrame:
    """path, writer as headers alone tell it."""
    classes, forest = found
    scored = forest.transform(metadata_vectors(reports))
    return scored.select("path", F.element_at(F.array(*map(F.lit, classes)), (F.col("prediction") + 1).cast("int")).alias("writer"))


# ---- experiments on archives --------------------------------------------------------------------------------------------


def zipfile_archive(parts: list[tuple[str, bytes]]) -> bytes:
    """Written by CPython's zipfile."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def own_archive(parts: list[tuple[str, bytes]]) -> bytes:
    """Written by our own writer and encoder."""
    return rewrite.write_zip([rewrite.deflated(name, data, encoders.own_raw(data, "lazy")) for name, data in parts])


WRITERS = {"python-zipfile": ("zlib", zipfile_archive), "own": ("own", own_archive)}
EDITORS = {"zlib": lambda data: encoders.zlib_raw(data), "own": lambda data: encoders.own_raw(data, "lazy")}
VARIANTS = ("genuine", "impersonated", "claimed", "edited")


def pick_editor(profile: str) -> str | None:
    """A profile other than the archive's whose encoder is at hand to edit with."""
    return next((name for name in EDITORS if name != profile), None)


def build_archives(sources: DataFrame, parts: int = PARTS) -> DataFrame:
    """(path, writer, profile, content): every group of `parts` sources (in the order of their id) by every writer."""
    order = Window.partitionBy(F.pmod(F.xxhash64("source_id"), F.lit(64))).orderBy("source_id")
    groups = sources.select("source_id", "content", F.pmod(F.xxhash64("source_id"), F.lit(64)).alias("b"), F.floor((F.row_number().over(order) - 1) / parts).alias("g"))
    listed = groups.groupBy("b", "g").agg(F.sort_array(F.collect_list(F.struct("source_id", "content"))).alias("s"))

    def run(batches):
        for batch in batches:
            out = []
            for b, g, members in zip(*(c.to_pylist() for c in batch.columns)):
                for writer, (profile, write) in WRITERS.items():
                    claim = f"<Properties><Application>assessment {writer}</Application></Properties>".encode()
                    named = [(rewrite.PROPERTIES, claim), *((f"word/part{k}.xml", m["content"]) for k, m in enumerate(members))]
                    out.append((f"{writer}-{b}-{g}.docx", writer, profile, write(named)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.binary()))], names=["path", "writer", "profile", "content"])

    return listed.mapInArrow(run, "path string, writer string, profile string, content binary")


def variants(archives: DataFrame, templates: dict[str, bytes]) -> DataFrame:
    """(path, variant, writer, profile, edited, content): each archive as it is, under another writer's headers, with
    another producer's claim, and with its largest part edited by another encoder."""

    def run(batches):
        for batch in batches:
            out = []
            for path, writer, profile, data in zip(*(c.to_pylist() for c in batch.columns)):
                entry, editor = rewrite.largest_entry(data), pick_editor(profile)
                other = next((t for w, t in sorted(templates.items()) if w != writer), None)
                claim = ("Microsoft Office Word", 3) if profile == "zlib" else ("LibreOffice/24.2", 0)
                made = {"genuine": data, "impersonated": rewrite.impersonate(data, other) if other else None, "claimed": rewrite.claim_with_bits(data, *claim), "edited": rewrite.edit(data, entry, EDITORS[editor]) if entry and editor else None}
                out += [(f"{v}/{path}", v, writer, profile, entry if v == "edited" else None, made[v]) for v in VARIANTS if made[v] is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.string()] * 5, pa.binary()))] if out else [pa.array([], t) for t in (*[pa.string()] * 5, pa.binary())], names=["path", "variant", "writer", "profile", "edited", "content"])

    return archives.select("path", "writer", "profile", "content").mapInArrow(run, "path string, variant string, writer string, profile string, edited string, content binary")


def experiments(archives: DataFrame, model: M.Model) -> DataFrame:
    """writer, variant, n and rates: right profile, flagged, and for edits the changed part singled out."""
    templates = {r["writer"]: bytes(r["content"]) for r in archives.orderBy("path").groupBy("writer").agg(F.first("content").alias("content")).collect()}
    made = E.cut(variants(archives, templates))
    found = analyse.analyse(made.select("path", "content"), model).select("path", F.col("profile").alias("said"), "status", "named")
    rows = made.drop("content").join(found, "path")
    flagged, share = F.col("status") == "inconsistent", lambda c: F.avg(c.cast("double"))
    return rows.groupBy("writer", "variant").agg(
        F.count("*").alias("n"), share(F.col("said") == F.col("profile")).alias("right_profile"), share(flagged).alias("flagged"),
        share(F.when(F.col("variant") == "edited", F.col("named") == F.array("edited"))).alias("localised"))


# ---- the run -------------------------------------------------------------------------------------------------------------


def source_split(rows: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """source_id, split: whole families go to test until 30 % of a content type's sources are there."""
    kinds = rows.select("source_id", F.col("content_type").alias("kind")).distinct()
    named = kinds.join(families, "source_id", "left").withColumn("family", F.coalesce("family", "source_id")) if families is not None else kinds.withColumn("family", F.col("source_id"))
    return named.join(E.family_split(named.groupBy("kind", "family").agg(F.count("*").alias("n"))).select("kind", "family", "split"), ["kind", "family"]).select("source_id", "split")


def evaluate(rows: DataFrame, families: DataFrame | None = None, trees: int = 40, leave_out: bool = False) -> dict[str, DataFrame]:
    """Tables of one evaluation of corpus rows: fitted on training families, measured on test families."""
    spark = rows.sparkSession
    split = E.cut(source_split(rows, families))
    chosen = E.cut(selection(rows, split))
    train, test = chosen.where("in_train"), chosen.where("in_test")
    model = M.fit(train, trees)
    programs = F.transform("labels", lambda x: F.split(x, ":", 2))
    by_profile = F.map_from_entries(F.transform("profiles", lambda p: F.struct(p, F.transform(programs, lambda x: x[1]))))
    said = E.cut(with_settings(model, setting_models(model, train.withColumn("settings", F.transform(programs, lambda x: x[1]))), model.predict(test.withColumn("settings", by_profile)).drop("z", "x")))
    known = said.where(F.col("profile").isNotNull())
    answered = ~F.col("abstained") & (F.col("compressed_bytes") >= model.min_bytes)
    judged = known.select(F.col("profile").alias("truth"), "top", answered.alias("answered"), F.when(answered, F.col("top")).alias("predicted"), (F.col("top") == F.col("profile")).alias("correct"), F.col("compressed_bytes").alias("size"))
    methods = known.select("profile", "profiles", "hash", F.when(answered, F.col("label")).alias("model"), F.col("top").alias("forced"))
    out = {
        "training": training_info(train), "overlap": E.overlaps(test.select("hash"), train, "hash").agg(F.count("*").alias("test streams that training has too")),
        "closed set": E.closed_set(judged), "profiles": E.class_metrics(judged), "size bands": E.size_bands(judged), "settings": setting_metrics(said),
        "methods": comparison(methods, ["model", "forced"]), "profile info": profile_info(train), **{f"novelty, {k}": v for k, v in novelty_report(model, known).items()},
    }
    if leave_out:
        out["left out"] = spark.createDataFrame(M.leave_one_out(train, trees), "profile string, n long, rejected double, taken_for map<string,long>")
    return out


# ---- stored models ---------------------------------------------------------------------------------------------------------


def stored_models(spark: SparkSession, root: str) -> DataFrame:
    """name, profiles, min_confidence, min_bytes of every model saved below a folder."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/*/meta").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("name"), F.from_json("body", "classes array<string>, min_confidence double, min_bytes long, temperature double").alias("b"))
    return rows.select("name", F.col("b.classes").alias("profiles"), "b.min_confidence", "b.min_bytes", "b.temperature").orderBy("name")
