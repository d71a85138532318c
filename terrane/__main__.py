"""Command line: ``python -m terrane list`` and ``python -m terrane run NAME FOLDER [--out PATH]``."""

from __future__ import annotations

import argparse

from terrane.plans import catalogue
from terrane.session import local_session

#: Commands of the surveyed tool and the queries that answer them.
COMMANDS = {
    "screen": "evidence_screen", "summarise": "evidence_screen_rank", "confirm": "permutation_evidence", "rank": "srci_source", "divergence": "structure_scores",
    "links": "spearman_links", "network": "network_complexity", "simulate": "simulated_scenarios", "recover": "simulated_recovery", "gate": "nested_feature_gate",
}


def main(args: list[str] | None = None) -> int:
    """Runs a command; returns the exit code."""
    parser = argparse.ArgumentParser(prog="terrane", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", help="a query or one of: " + ", ".join(COMMANDS))
    run.add_argument("folder")
    run.add_argument("--out", help="folder for the rows as Parquet; without it the first rows are shown")
    given = parser.parse_args(args)
    if given.what == "list":
        for name in sorted(catalogue.QUERIES):
            print(name, *catalogue.COVERS[name])
        return 0
    name = COMMANDS.get(given.name, given.name)
    if name not in catalogue.QUERIES:
        parser.error(f"no query or command {given.name!r}")
    rows = catalogue.QUERIES[name](local_session(), given.folder)
    if given.out:
        rows.write.mode("overwrite").parquet(given.out)
    else:
        rows.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
