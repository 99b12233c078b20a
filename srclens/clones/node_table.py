"""Syntax nodes as a table: what lies around and below each node."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANNOTATED = "file_id bigint, idx int, kind string, item int, in_test boolean, has_error boolean"


def annotate(nodes: DataFrame, items: tuple[str, ...]) -> DataFrame:
    """``file_id``, ``idx``, ``kind``, ``item`` (idx of the innermost node of an item's kind around it; null for none), ``in_test``
    and ``has_error`` (of the node or of any below it) of every node.

    ``nodes``: file_id, idx, end_idx, kind, test, error, in preorder within a file. A sorted partition is read once with a
    stack of the nodes that are still open, so that a file costs its number of nodes, and memory its depth. Null flags
    count as false; of repeated rows one counts.
    """
    kinds = frozenset(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []  # file, idx, end, kind, item around, test, error
        out: list[tuple] = []

        def close() -> None:
            file, idx, _, kind, item, test, error = stack.pop()
            out.append((file, idx, kind, item, test, error))
            if stack:
                stack[-1][5] |= test
                stack[-1][6] |= error

        for pdf in batches:
            for file, idx, end, kind, test, error in zip(*(pdf[c].tolist() for c in ("file_id", "idx", "end_idx", "kind", "test", "error"))):
                while stack and (stack[-1][0] != file or stack[-1][2] <= idx):
                    close()
                around = (stack[-1][1] if stack[-1][3] in kinds else stack[-1][4]) if stack else None
                stack.append([file, idx, end, kind, around, bool(test), bool(error)])
            yield _rows(out)
            out.clear()
        while stack:
            close()
        yield _rows(out)

    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("test", "error")]
    rows = nodes.select("file_id", "idx", "end_idx", "kind", *flags).dropDuplicates(["file_id", "idx"])
    return rows.repartition("file_id").sortWithinPartitions("file_id", "idx").mapInPandas(run, ANNOTATED)


def _rows(out: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(out, columns=["file_id", "idx", "kind", "item", "in_test", "has_error"])
    return pdf.astype({"item": "Int32"})
