"""Hybrid search from a shell, as CSV: python -m ledgerloom.cli TOPIC FOLDER [LIMIT]."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ledgerloom.operators import exports
from ledgerloom.operators import search as S
from ledgerloom.session import session
from ledgerloom.tables import table


def found(spark, topic: str, folder: str, limit: int = 50):
    """The documents that fit a topic best, at most 200."""
    terms = topic.lower().split() or [topic]
    best = S.top(S.bm25(table(spark, folder, "documents"), "doc_id", "text", terms), "doc_id", max(1, min(limit, exports.MOST_ROWS)))
    return best.join(table(spark, folder, "documents"), "doc_id").select("doc_id", "score", "source", "lang", F.left("text", F.lit(150)).alias("excerpt")).orderBy(F.desc("score"), "doc_id")


def main(arguments: list[str]) -> None:
    topic, folder, *rest = arguments
    rows = found(session("local[*]"), topic, folder, int(rest[0]) if rest else 50)
    print(exports.csv_header(rows))
    for line in exports.csv_lines(rows).collect():  # bounded by the limit
        print(line.value)


if __name__ == "__main__":
    main(sys.argv[1:])
