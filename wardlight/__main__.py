"""python -m wardlight IN OUT [--languages en,fr] [--stream]: answers lines of JSON under IN as JSON lines under OUT."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from . import __version__
from .operators.moderation import for_languages
from .streaming import messages


def arguments(argv: list[str] | None = None, env=os.environ) -> argparse.Namespace:
    """Languages come from --languages, else from WARDLIGHT_LANGUAGES, else all are loaded."""
    p = argparse.ArgumentParser(prog="wardlight")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--languages", default=env.get("WARDLIGHT_LANGUAGES"), help="codes joined by commas")
    p.add_argument("--stream", action="store_true", help="follow new files until they are all answered")
    p.add_argument("-v", "--version", action="version", version=__version__)
    found = p.parse_args(argv)
    found.languages = [c.strip() for c in found.languages.split(",") if c.strip()] if found.languages else None
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(argv)
    options = for_languages(a.languages)
    spark = spark or SparkSession.builder.appName("wardlight").getOrCreate()
    if a.stream:
        q = messages.stream_lines(spark, a.source, options).writeStream.format("json").option("checkpointLocation", f"{a.target}.checkpoint").trigger(availableNow=True).start(a.target)
        q.awaitTermination()
    else:
        messages.answer(spark.read.text(a.source), options).write.mode("errorifexists").json(a.target)


if __name__ == "__main__":
    main()
