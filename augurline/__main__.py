from augurline.cli import run

raise SystemExit(run())
