"""Fill-in-middle transformation: DuckDB SQL over each Arrow batch inside mapInArrow.

A text is cut into units, a prefix, a middle and a suffix of whole units, and put together again so
that the middle comes last. Which units go where depends on the row's key alone, so a retried task
gives the same rows. A batch is registered with an in-process DuckDB connection and comes back as
Arrow; no row is touched in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run of letters is one unit, and so is any other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, how many stay plain, and of the others how many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
BATCH_BYTES = 4 << 20


def transform_sql(table: str, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> str:
    """SQL from a table of key, text to key, n, form, prefix_chars, middle_chars, output and text."""
    p, s, m = MARKS
    group = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    return f"""
WITH given AS (
  SELECT key, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(key AS VARCHAR), '')) AS h FROM {table}
), units AS (
  SELECT key, text, {", ".join(f"{group(k)} AS h{k + 1}" for k in range(4))}, regexp_extract_all(text, '{UNIT}') AS u FROM given
), cuts AS (
  SELECT key, text, u, len(u) AS n,
    CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {100 - plain} THEN 'plain'
      WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT key, text, n, form, array_to_string(list_slice(u, 1, a), '') AS prefix,
    array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix
  FROM cuts
)
SELECT key, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
    ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output
FROM parts"""


def restore_sql(table: str) -> str:
    """SQL from a table with form and output to the same columns and restored, the text read back from these two alone.

    No part holds a mark, and a mark begins with the only "<" it has, so the first mark of its kind
    behind the start is the one that was put there.
    """
    p, s, m = MARKS
    return f"""
WITH opened AS (
  SELECT *, substr(output, 4) AS body, CASE form WHEN 'psm' THEN '{s}' ELSE '{p}' END AS next FROM {table}
), first_ AS (
  SELECT * EXCLUDE body, split_part(body, next, 1) AS one, substr(body, length(split_part(body, next, 1)) + 4) AS rest FROM opened
), second_ AS (
  SELECT * EXCLUDE (rest, next), split_part(rest, '{m}', 1) AS two, substr(rest, length(split_part(rest, '{m}', 1)) + 4) AS middle FROM first_
)
SELECT * EXCLUDE (one, two, middle), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || middle || two ELSE two || middle || one END AS restored
FROM second_"""


def _parts(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes; a longer text is a slice of its own."""
    at = 0
    while at < batch.num_rows:
        rows = batch.num_rows - at
        while rows > 1 and batch.slice(at, rows).get_total_buffer_size() and batch.slice(at, rows).nbytes > most:
            rows = -(-rows // 2)
        yield batch.slice(at, rows)
        at += rows


def _through(sql: str, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": "1", "preserve_insertion_order": "true"}) as con:
            for batch in batches:
                for part in _parts(batch):
                    con.register("given_rows", pa.Table.from_batches([part]).rename_columns(list(names)))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("given_rows")

    return run


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output: one row for each row of docs.

    n counts the units of the whole text; the code points of prefix and middle are null for form
    plain. A null or empty text is plain and empty; a text that holds a mark stays plain. Rows of one
    key are cut by the same draws; a null key draws like an empty one. Repeated rows stay, other
    columns are not read, and an empty table gives an empty one. A task holds the units of some
    megabytes of text, or of its longest text.
    """
    rows = docs.select(docs[key], docs[text])
    kind = rows.schema[0].dataType.simpleString()
    sql = transform_sql("given_rows", seed, plain, suffix_first)
    made = rows.mapInArrow(_through(sql, ("key", "text")), f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def restore(made: DataFrame) -> DataFrame:
    """form, output and restored of transformed rows: the exact text, from form and output alone. Null outputs give null."""
    return made.select("form", "output").mapInArrow(_through(restore_sql("given_rows"), ("form", "output")), "form string, output string, restored string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """As fill_in_middle and restore in one pass, with the SHA-256 of output and restored text in their place."""
    rows = docs.select(docs[key], docs[text])
    kind = rows.schema[0].dataType.simpleString()
    sql = f"""WITH made AS ({transform_sql("given_rows", seed)}), back AS ({restore_sql("made")})
SELECT key, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back"""
    made = rows.mapInArrow(_through(sql, ("key", "text")), f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    return made.withColumnRenamed("key", key)
