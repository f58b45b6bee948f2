"""Command line: audit, test and reproduce."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="augurline", description="Tests of strategy returns and forecast studies on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("audit", "test"):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--output", default="-" if name == "test" else None, required=name == "audit", help="a file, or - for standard output")
        p.add_argument("--benchmark")
        p.add_argument("--alpha", type=float, default=0.05)
        p.add_argument("--resamples", "--n-resamples", dest="n_resamples", type=int)
        p.add_argument("--block-length", type=float)
        p.add_argument("--lags", type=int)
        p.add_argument("--seed", type=int)
        p.add_argument("--studentization", choices=("fixed", "resampled"))
        if name == "audit":
            p.add_argument("--report", help="also write an HTML page")
            search = p.add_mutually_exclusive_group()
            search.add_argument("--complete-search", dest="search_complete", action="store_const", const=True)
            search.add_argument("--incomplete-search", dest="search_complete", action="store_const", const=False)
        else:
            p.add_argument("--method", choices=("bootstrap", "gaussian_ar"), default="bootstrap")
            p.add_argument("--format", choices=("json", "csv"), help="csv for files that end so, else json")
            p.add_argument("--beta", type=float)
            p.add_argument("--max-dimension", type=int)
            p.add_argument("--block-lengths", type=int, nargs="+")
    p = commands.add_parser("reproduce")
    p.add_argument("--profile", choices=("quick", "full"), default="quick")
    p.add_argument("--study", choices=("baseline", "calibration"), default="baseline")
    p.add_argument("--seed", type=int)
    p.add_argument("--output", required=True)
    return top


def write(output: str, text: str) -> None:
    if output == "-":
        print(text)
    else:
        Path(output).write_text(text)


def reproduced(spark, study: str, profile: str, seed: int | None) -> dict:
    """The result of a study."""
    from augurline.operators import calibrate, simulate

    quick = profile == "quick"
    if study == "calibration":
        grid = calibrate.cells(profile)
        found = calibrate.decisions(spark, grid, resamples=calibrate.PROFILES[profile]["resamples"], seed=calibrate.SEED if seed is None else seed).cache()
        rows = calibrate.rates(found, grid)
        return {"study": study, "profile": profile, "assessment": calibrate.assessment(rows, profile), "rates": rows, "variance_ratios": [r.asDict() for r in calibrate.variance_ratios(found).orderBy("cell", "block_length").collect()]}
    cells = [{"n": 512, "k": k, "phi": phi} for k, phi in ((1, 0.0), (1, 0.5), (1, 0.8), (10, 0.5), (50, 0.5))]
    rates = simulate.rejection_rates(simulate.study(spark, cells, 50 if quick else 2000, n_resamples=199 if quick else 1999, seed=seed or 0))
    return {"study": study, "profile": profile, "rates": [{**cells[r["cell"]], **r.asDict()} for r in rates.orderBy("cell", "method").collect()]}


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        from pyspark.sql import SparkSession

        from augurline.operators import bootstrap
        from augurline.plans.shipping import ship
        from augurline.report import html_report
        from augurline.sources.returns_csv import read_returns_csv

        spark = SparkSession.builder.appName("augurline").getOrCreate()
        ship(spark)
        if args.command == "reproduce":
            write(args.output, json.dumps(reproduced(spark, args.study, args.profile, args.seed), indent=1))
            return 0
        source = Path(args.path)
        if args.output != "-" and source.resolve() == Path(args.output).resolve():
            raise ValueError("output must not be the input")
        content = source.read_bytes()
        panel = read_returns_csv(spark, f"file://{source.resolve()}", benchmark=args.benchmark)
        names = ("n_resamples", "block_length", "lags", "seed", "studentization", "search_complete", "beta", "max_dimension", "block_lengths")
        options = {k: v for k in names if (v := getattr(args, k, None)) is not None}
        if args.command == "audit":
            found = bootstrap.audit(panel, alpha=args.alpha, **options).cache()
            if args.report:
                warnings = found.select("warnings").first()[0]
                Path(args.report).write_text(html_report(found.drop("panel_id", "warnings").orderBy("col"), f"Audit of {source.name}", tuple(warnings)))
        else:  # an option that the method doesn't have is refused
            found = bootstrap.test_returns(panel, method=args.method, alpha=args.alpha, **options)
        frame = found.drop("panel_id").orderBy("col").toPandas()
        if args.command == "test" and (args.format or ("csv" if args.output.endswith(".csv") else "json")) == "csv":
            write(args.output, frame.drop(columns=[c for c in ("warnings", "interval_bounds", "exact_bounds") if c in frame]).to_csv(index=False))
        else:
            write(args.output, json.dumps({"schema_version": 1, "input_sha256": hashlib.sha256(content).hexdigest(), "rows": json.loads(frame.to_json(orient="records"))}, indent=1))
        return 0
    except (TypeError, ValueError, OSError, ImportError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(run())
