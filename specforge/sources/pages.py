"""Page sources: light text and the one step that needs a parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import rules
from specforge.functions import text


def light_text(html: Column, max_chars: int | None = None) -> Column:
    """Tags to blanks, blanks collapsed; the whole page unless a cut is asked for."""
    h = html if max_chars is None else F.substring(html, 1, max_chars)
    return text.squeeze(F.regexp_replace(h, "<[^>]*>", " "))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt to as many tasks as the session's shuffles have.

    For narrow rows that each need much work: a small file is else read by a task
    per row group, however many cores there are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def parse_pages(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """(keep columns, body_text, tables array<array<array<string>>>), Arrow batches.

    Blocks, rows and cells end lines of the text.  The parser class lives inside the
    task function, so executors need nothing but the standard library and Arrow.  A
    batch is read page by page and handed on in slices of about `rules.PARSED_CHARS`
    characters of pages, so a task never holds the parsed form of a whole batch.
    """
    blocks, most = rules.LINE_TAGS, rules.PARSED_CHARS
    passed = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keep)
    schema = passed + "body_text string, tables array<array<array<string>>>"

    def run(batches):
        from html.parser import HTMLParser

        import pyarrow as pa
        lines = frozenset(blocks)
        kinds = [pa.string(), pa.list_(pa.list_(pa.list_(pa.string())))]

        class Reader(HTMLParser):
            """Collects body text and the cells of every table, nested ones too."""

            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.text, self.tables, self.open = [], [], []
                self.skip = 0

            def handle_starttag(self, tag, attrs):
                if tag in lines:
                    self.text.append("\n")
                if tag in ("script", "style", "head", "noscript"):
                    self.skip += 1
                elif tag == "table":
                    rows = []
                    self.tables.append(rows)
                    self.open.append((rows, []))
                elif tag == "tr" and self.open:
                    self.open[-1][0].append([])
                elif tag in ("td", "th") and self.open and self.open[-1][0]:
                    self.open[-1][0][-1].append("")
                    self.open[-1][1].append(True)

            def handle_endtag(self, tag):
                if tag in lines:
                    self.text.append("\n")
                if tag in ("script", "style", "head", "noscript"):
                    self.skip = max(0, self.skip - 1)
                elif tag == "table" and self.open:
                    self.open.pop()
                elif tag in ("td", "th") and self.open and self.open[-1][1]:
                    self.open[-1][1].pop()

            def handle_data(self, data):
                if self.skip:
                    return
                self.text.append(data)
                for rows, cells in self.open:
                    if cells and rows and rows[-1]:
                        rows[-1][-1] += data

        def parsed(page):
            reader = Reader()
            if page is not None:
                reader.feed(page)
                reader.close()
            body = "\n".join(x for x in (" ".join(line.split()) for line in "".join(reader.text).split("\n")) if x)
            return body, [[[" ".join(c.split()) for c in r] for r in t if r] for t in reader.tables]

        def slice_of(batch, start, done):
            given = batch.slice(start, len(done))
            made = [pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*(given.column(k) for k in keep), *made], [*keep, "body_text", "tables"])

        for batch in batches:
            start, chars, done = 0, 0, []
            for page in batch.column(html):
                page = page.as_py()
                done.append(parsed(page))
                chars += len(page or "")
                if chars >= most:
                    yield slice_of(batch, start, done)
                    start, chars, done = start + len(done), 0, []
            if done:
                yield slice_of(batch, start, done)
    return df.select(*keep, html).mapInArrow(run, schema)
