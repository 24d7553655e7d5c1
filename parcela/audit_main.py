"""Command line of the audit: ``python -m parcela.audit_main --csv FILES --output REPORT --format csv|md|both --exclude-types TYPE ...``."""

from __future__ import annotations

import argparse
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parcela.operators import audit
from parcela.sources import listing_csv


def with_suffix(path: str, suffix: str) -> str:
    """``path`` with ``suffix``, unless it has it in any case."""
    p = PurePosixPath(path)
    return path if p.suffix.lower() == suffix else str(p.with_suffix(suffix))


def run(spark: SparkSession, files: str, output: str, form: str = "both", exclude: tuple[str, ...] = ()) -> dict[str, str]:
    """Audit the records of ``files``; writes the reports and returns their paths by format."""
    rows = listing_csv.read(spark, files).withColumn("row_id", F.col("nro_linea") - 1)
    found, written = audit.issues(rows, exclude=exclude), {}
    if form in ("csv", "both"):
        written["csv"] = with_suffix(output, ".csv")
        audit.write_csv(found, written["csv"])
    if form in ("md", "both"):
        written["md"] = with_suffix(output, ".md")
        audit.write_markdown(found, files, written["md"])
    return written


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--csv", required=True)
    parser.add_argument("--output", "-o", default="audit_cleaning_report.csv")
    parser.add_argument("--format", choices=("csv", "md", "both"), default="both")
    parser.add_argument("--exclude-types", nargs="+", default=())
    given = parser.parse_args(arguments)
    from parcela.session import build_session

    spark = SparkSession.getActiveSession() or build_session(app="audit")
    for form, path in run(spark, given.csv, given.output, given.format, tuple(given.exclude_types)).items():
        print(f"{form}: {path}")


if __name__ == "__main__":
    main()
