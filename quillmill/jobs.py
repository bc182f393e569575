"""Jobs for the command line: ``python -m quillmill.jobs NAME INPUT OUTPUT [options]``.

INPUT is read by its ending (.txt, .csv, .json, .parquet; a folder of pages for ``extract``), OUTPUT is a
folder of Parquet unless ``--format`` says otherwise. ``--config`` is a JSON file of the job's settings.
``--analyze`` prints the statistics and writes nothing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill import config as C
from quillmill.operators import content, decontaminate, exact, html, language, license, near, quality
from quillmill.sources import readers, writers

_KINDS = {"exact": C.ExactConfig, "near": C.NearConfig, "quality": C.QualityConfig, "language": C.LanguageConfig, "decontaminate": C.DecontaminationConfig, "content": C.ContentConfig, "license": C.LicenseConfig}


def _with_ids(docs: DataFrame) -> DataFrame:
    return docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.monotonically_increasing_id())


def _exact(docs, settings, args):
    return (exact.statistics(docs, settings),) if args.analyze else (exact.deduplicate(docs, settings),)


def _near(docs, settings, args):
    if args.analyze:
        return (near.groups(docs, settings).groupBy("leader").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "leader"),)
    return (near.deduplicate(docs, settings),)


def _quality(docs, settings, args):
    return (quality.statistics(docs, settings),) if args.analyze else (quality.keep(docs, settings),)


def _language(docs, settings, args):
    return (language.statistics(docs),) if args.analyze else (language.language_filter(settings).keep(docs, "decision = 'keep'"),)


def _decontaminate(docs, settings, args):
    if not args.benchmark:
        raise SystemExit("decontaminate needs --benchmark")
    indexed = decontaminate.index(readers.read_benchmark(docs.sparkSession, args.benchmark), "dataset", settings)
    if args.analyze:
        return (decontaminate.statistics(decontaminate.assess(docs, indexed, settings)),)
    return (decontaminate.clean(docs, indexed, settings),)


def _content(docs, settings, args):
    private = content.PRESETS[args.preset][1]
    settings = settings if args.config else content.PRESETS[args.preset][0]
    done = content.process(docs, settings, "url" if "url" in docs.columns else None, private)
    return (content.statistics(done),) if args.analyze else (content.merged(docs, done),)


def _license(docs, settings, args):
    found = license.license_filter(settings, "url" if "url" in docs.columns else None).spark(docs)
    if args.analyze:
        return (license.statistics(found),)
    return (docs.join(found.where("result = 'KEEP'").select("doc_id"), "doc_id", "left_semi"),)


def _extract(pages, settings, args):
    done = html.extract(pages)
    return (html.report(done),) if args.analyze else (done.select("url", "extracted.*"),)


JOBS = {"exact": _exact, "near": _near, "quality": _quality, "language": _language, "decontaminate": _decontaminate, "content": _content, "license": _license, "extract": _extract}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmill.jobs", description=__doc__.splitlines()[0])
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--text-column", default="text")
    p.add_argument("--format", choices=("txt", "csv", "json", "parquet"), default="parquet")
    p.add_argument("--config", help="settings as JSON")
    p.add_argument("--benchmark", help="a file or folder of test items, one a line")
    p.add_argument("--preset", choices=sorted(content.PRESETS), default="default")
    p.add_argument("--analyze", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """Run a job; its result."""
    args = parser().parse_args(argv)
    if not args.analyze and not args.output:
        raise SystemExit("an output folder, or --analyze")
    kind = _KINDS.get(args.job)
    settings = kind and (C.load_config(kind, args.config) if args.config else kind())
    docs = readers.read_html(spark, args.input) if args.job == "extract" else _with_ids(readers.read_documents(spark, args.input, args.text_column))
    (out,) = JOBS[args.job](docs, settings, args)
    if args.analyze:
        out.show(50, truncate=False)
    else:
        writers.write_documents(out, args.output, args.format)
    return out


def main() -> None:
    spark = SparkSession.builder.appName("quillmill").getOrCreate()
    run(spark, sys.argv[1:])
    spark.stop()


if __name__ == "__main__":
    main()
