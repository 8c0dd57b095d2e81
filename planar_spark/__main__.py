"""Command line: ``python -m planar_spark --store PATH create-tables | update | update-contacts | update-faces | reset | delete | show-errors | clean-topology``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import TopoConfig
from .plans.solve import TopoSession
from .streaming.watch import watch


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="planar_spark")
    p.add_argument("--store", required=True)
    p.add_argument("--srid", type=int, default=4326)
    p.add_argument("--tolerance", type=float, default=1e-5)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("create-tables")
    update = sub.add_parser("update")
    update.add_argument("--reset", action="store_true", help="forget derived tables first")
    update.add_argument("--fill-holes", action="store_true", help="solve again where faces have no map face")
    update.add_argument("--fix-failed", action="store_true", help="accepted: every update tries lines with errors again")
    update.add_argument("--whole", action="store_true", help="solve everything, not only what changed")
    update.add_argument("--watch", metavar="FOLDER", help="then follow an edit log")
    reset = sub.add_parser("reset")
    reset.add_argument("--yes", action="store_true")
    for name in ("update-contacts", "update-faces", "delete", "show-errors", "clean-topology"):
        sub.add_parser(name)
    a = p.parse_args(argv)
    session = TopoSession(SparkSession.builder.getOrCreate(), a.store, TopoConfig(a.srid, a.tolerance))
    if a.command == "create-tables":
        session.store.create_empty()
        session.seed()
    elif a.command == "update":
        if a.reset:
            session.reset()
        if a.fill_holes:
            session.fill_holes()
        session.update(whole=a.whole)
        session.clean()
        if a.watch:
            watch(session, a.watch, f"{a.store}/watch").awaitTermination()
    elif a.command == "update-contacts":
        session.update_contacts()
    elif a.command == "update-faces":
        session.update_faces()
    elif a.command == "reset":
        if not a.yes and input("Forget the topology? [y/N] ").lower() != "y":
            return 1
        session.reset()
    elif a.command == "delete":
        session.forget()
    elif a.command == "show-errors":
        session.store.read("linework_topo").where("topology_error is not null").show(truncate=False)
    else:
        session.clean()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
