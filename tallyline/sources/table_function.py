"""``statement_cells``: the cells of a statement that a table holds as text, for SQL."""

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tallyline.sources import files
from tallyline.sources.statement_format import kind_of


@udtf(returnType="file string, sheet int, row_idx int, cells array<string>, error string")
class StatementCells:
    """A row for each row of each sheet; one with an error where the content is not readable, none where it is null or has no rows.

    Beside each row: ``FROM t, LATERAL statement_cells(t.file, t.content)``, without a shuffle. For a table with the columns file and
    content: ``FROM statement_cells(TABLE(t) PARTITION BY file)``. The content is html or csv as a string, or any file as binary.
    A result stands on its own, so how rows are dealt to tasks changes nothing.
    """

    def eval(self, file, content=None) -> Iterator[tuple]:
        if isinstance(file, Row):
            file, content = file["file"], file["content"]
        if content is None:
            return
        data = content.encode() if isinstance(content, str) else bytes(content)
        try:
            if isinstance(content, str) and kind_of(data, file or "") == "html":
                # The text is decoded already, whatever encoding the page says it has.
                sheets = list(files.read_html(b'<meta charset="utf-8">' + data))
            else:
                sheets = files._sheets(data, kind_of(data, file or ""))[1]
        except Exception as e:  # noqa: BLE001 - whatever a broken file raises is its error
            yield file, 0, 0, None, f"{type(e).__name__}: {e}"
            return
        for s, (_, rows) in enumerate(sheets):
            for r, row in enumerate(files.trimmed(rows)):
                yield file, s, r, [files.shown(v)[0] for v in row], None


def register(spark: SparkSession) -> None:
    """Makes ``statement_cells`` known to a session's SQL."""
    spark.udtf.register("statement_cells", StatementCells)
