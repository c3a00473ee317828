"""Table functions of SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="text string, run_id long, chain string, piece string")
class SplitByChain:
    """The lines of one text, in order, as pieces: a new one begins wherever the chain is another than before.

    SELECT * FROM split_by_chain(TABLE(lines) PARTITION BY text ORDER BY line_no), where lines has text (a
    name of each, as a string), chain and text_line. Null lines add nothing; null chains are alike.
    """

    def __init__(self) -> None:
        self.text, self.number, self.chain, self.lines = None, -1, None, []

    def eval(self, row: Row) -> Iterator[tuple[str | None, int, str | None, str]]:
        if self.number < 0 or row["chain"] != self.chain:
            yield from self.terminate()
            self.text, self.number, self.chain, self.lines = row["text"], self.number + 1, row["chain"], []
        self.lines.append(row["text_line"])

    def terminate(self) -> Iterator[tuple[str | None, int, str | None, str]]:
        if self.number >= 0:
            yield self.text, self.number, self.chain, "\n".join(x for x in self.lines if x is not None)


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_by_chain", SplitByChain)
