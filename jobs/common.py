"""What both jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from panoply.session import session

LOG = logging.getLogger("jobs")


def config(name: str, path: str | None = None) -> dict:
    """The job's own settings; a file may change some of them, and no others."""
    held = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    own = json.loads(Path(path).read_text()) if path else {}
    if unknown := own.keys() - held.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return held | own


def main(name: str, run, arguments: dict[str, str]) -> None:
    """The only place that creates and stops a session."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for a, text in arguments.items():
        parser.add_argument(a, help=text)
    parser.add_argument("--config", help="a JSON file with some of the settings")
    a = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = config(name, a.pop("config"))
    spark = session(f"job-{name}")
    try:
        run(spark, *a.values(), settings)
    finally:
        spark.stop()
