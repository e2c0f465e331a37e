"""Command line: thin calls of the plans.  `python -m flatewise VERB ...`."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    spark = SparkSession.builder.appName("flatewise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise SystemExit("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flatewise-"))
    return spark


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="flatewise")
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name, *options):
        p = verbs.add_parser(name)
        for o in options:
            p.add_argument(*o[0], **o[1])

    path, model = (("path",), {}), (("--model",), {"default": None})
    verb("analyse", path, model, (("--html",), {"default": None}), (("--fail-on-inconsistent",), {"action": "store_true"}))
    verb("inspect", path)
    verb("reencode", path)
    verb("corpus", (("out",), {}), (("--dir",), {"default": None}), (("--limit",), {"type": int, "default": None}))
    verb("train", (("corpus",), {}), (("out",), {}), (("--trees",), {"type": int, "default": 150}))
    verb("evaluate", (("corpus",), {}), (("--trees",), {"type": int, "default": 40}), (("--leave-out",), {"action": "store_true"}), (("--html",), {"default": None}))
    verb("app", path, (("name",), {}), (("out",), {}))
    verb("models", (("root",), {}))
    verb("experiments", (("model",), {}), (("--dir",), {"default": None}))
    verb("encoders")
    verb("producers")
    verb("covert-embed", path, (("message",), {}), (("out",), {}))
    verb("covert-detect", path)
    a = parser.parse_args(argv)

    from flatewise.operators import covert, encoders, inflate, streams
    from flatewise.plans import analyse, assess, report, verdict
    from flatewise.plans import model as models
    from flatewise.sources import containers, corpus

    if a.verb == "encoders":
        for e in encoders.list_encoders(only_available=False):
            print(e.name, e.library, "available" if e.available else "not here", "reference" if e.reference else "", ",".join(e.settings))
        return 0
    if a.verb == "producers":
        for key, label, *_ in verdict.PRODUCERS:
            print(key, label)
        return 0
    if a.verb == "covert-embed":
        with open(a.path, "rb") as f:
            raw = f.read()
        with open(a.out, "wb") as f:
            f.write(covert.embed(raw, covert.to_bits(a.message.encode())))
        return 0
    if a.verb == "inspect":
        with open(a.path, "rb") as f:
            found = containers.scan(a.path, f.read())
        for s in found["streams"]:
            r = inflate.parse(s["payload"])
            print(s["name"], f"{len(r.blocks)} blocks, {r.n_tokens} tokens, {r.out_size} bytes, ending {inflate.ending(r)}", r.error or "")
        return 0
    spark = session()
    if a.verb == "analyse":
        loaded = models.load(spark, a.model) if a.model else None
        rows = [r.asDict(recursive=True) for r in analyse.analyse_path(spark, a.path, loaded).collect()]
        print(json.dumps(rows, indent=2, default=str))
        if a.html:
            with open(a.html, "w", encoding="utf-8") as f:
                f.write("".join(report.verdict_html(r, []) for r in rows))
        return int(a.fail_on_inconsistent and any(r["status"] == "inconsistent" for r in rows))
    if a.verb in ("reencode", "covert-detect"):
        found = containers.stream_rows(containers.scan_table(containers.read_files(spark, a.path)))
        records = streams.decode(found.select("path", "name", "payload", found["payload"].alias("_p")), "_p", output=True)
        (streams.proofs(records).select("path", "name", "zlib_proof") if a.verb == "reencode" else analyse.padding_score(records)).show(100, False)
        return 0
    if a.verb == "corpus":
        made = corpus.synthetic(spark)
        if a.dir:
            made = made.unionByName(corpus.directory(containers.read_files(spark, a.dir), a.limit))
        rows, errors = corpus.build(made)
        corpus.save(rows, a.out)
        print(f"{errors.count()} settings failed")
        return 0
    if a.verb == "models":
        assess.stored_models(spark, a.root).show(100, False)
        return 0
    if a.verb == "app":
        found = containers.stream_rows(containers.scan_table(corpus.documents_in(spark, a.path)))
        files = corpus.documents_in(spark, a.path).select("path", F.sha2("content", 256).alias("file_hash"))
        described = streams.proofs(streams.decode(found.select("path", "payload", found["payload"].alias("_p")), "_p", output=True))
        rows = described.select("path", "payload", F.sha2("payload", 256).alias("hash"), F.col("compressed_bytes").alias("size"), F.col("zlib_proof").isNotNull().alias("reproduced"), F.lit(a.name).alias("app")).join(files, "path")
        assess.add_application(rows, "zlib").write.mode("overwrite").parquet(a.out)
        return 0
    if a.verb == "experiments":
        made = corpus.directory(containers.read_files(spark, a.dir)) if a.dir else corpus.synthetic(spark, sizes=(6000, 24000), per=2, seed=1)
        assess.experiments(assess.build_archives(made), models.load(spark, a.model)).orderBy("writer", "variant").show(100, False)
        return 0
    rows = corpus.load(spark, a.corpus)
    if a.verb == "train":
        models.fit(rows, a.trees).save(a.out)
        return 0
    sections = {name: [r.asDict(recursive=True) for r in found.limit(1000).collect()] for name, found in assess.evaluate(rows, None, a.trees, a.leave_out).items()}
    print(json.dumps(sections, indent=2, default=str))
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(report.evaluation_html(sections))
    return 0


if __name__ == "__main__":
    sys.exit(main())
